"""What several operators share: table access, shared scratch tables, components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.scratch import drop, scratch_path as shared_dir, stored as materialize
from quire.sources.tables import table

SEED = 42
FREQUENT = 100_000  # rows of a few dozen bytes that may be broadcast


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df does not have, in Spark's case-blind sense."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed_join(left: DataFrame, right: DataFrame, on: Column, n: str, how: str = "inner", most: int = FREQUENT) -> DataFrame:
    """left joined to right, whose keys are unique and whose column n tells how often left has them.

    A small right side is broadcast. Of a larger one the keys that are most frequent
    on left are broadcast and the others shuffled, so no key of the shuffle is hot. Both sides must be stored
    tables, as they are read more than once. how: inner, left or left_semi.
    """
    if right.count() <= most:
        return left.join(F.broadcast(right), on, how)
    edge = right.select(n).orderBy(F.desc(n)).limit(most).agg(F.min(n)).first()[0]
    hot, cold = right.where(F.col(n) > edge), right.where(F.col(n) <= edge)  # fewer than most rows are above the edge
    rest = left.join(F.broadcast(hot), on, "left_anti")
    return left.join(F.broadcast(hot), on, "inner" if how == "left" else how).unionByName(rest.join(cold, on, how))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v); skewed nodes stay joins, so AQE can split them."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = both.join(least, both.u == least.k)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table by alternating large-star and small-star steps.

    Returns (node, component) for every node with an edge to another; component is
    the smallest reachable node, itself included. Every round is written to the
    shared folder; the edges shrink to stars in O(log^2 n) rounds. Edges with a
    null end and loops are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    path = shared_dir(spark)
    e, old, seen = materialize(e, path), path, None
    for _ in range(max_rounds):
        path = shared_dir(spark)
        e = materialize(_star(_star(e, True), False), path)
        drop(spark, old)
        old = path
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def survivors(docs: DataFrame, classes: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of docs for each component of classes (h, component), h being xxhash64 of the text.

    The smallest id stays, rows without one come last, then the text hash decides. Texts
    are shuffled once; only rows that repeat both id and text are grouped again.
    """
    k, h, again = fresh(docs, "k", "h", "again")
    places = docs.select(F.xxhash64(text).alias("t_h"), F.col(key).isNull().alias("none"), F.col(key).alias("k")).groupBy("t_h", "none", "k").agg((F.count("*") > 1).alias("again"))
    least = places.groupBy("t_h").agg(F.min(F.struct("none", "k", "again")).alias("first"))
    one = least.join(classes, F.col("t_h") == F.col("h")).groupBy("component").agg(F.min(F.struct("first.none", "first.k", "t_h", "first.again")).alias("one"))
    one = materialize(one.select(F.col("one.k").alias(k), F.col("one.t_h").alias(h), F.col("one.again").alias(again)))

    def rows(of: DataFrame) -> DataFrame:
        return docs.join(of, docs[key].eqNullSafe(of[k]) & (F.xxhash64(docs[text]) == of[h]), "left_semi")

    single, repeated = one.where(~F.col(again)), one.where(F.col(again))
    return rows(single) if repeated.isEmpty() else rows(single).unionByName(rows(repeated).dropDuplicates([key, text]))


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the smallest of its connected part, for the parts of an edge list in memory."""
    nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def bytes_of(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty and unpaired surrogates become '?'."""
    return (text or "").encode("utf-8", "replace")


WORD = re.compile(rb"[^\x20\x09-\x0d]+")
