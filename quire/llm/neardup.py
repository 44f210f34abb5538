"""Near-duplicates by similarity, for simhash.keep_one: Jaccard similarity of word shingles of at least 0.8.

Texts of one shingle set are one node. A node has 120 minima of hashed shingles in 24
bands of five; nodes that agree in a band meet in a bucket, and every pair that meets
and is not known to be in one component is verified by its shingles. Two nodes of similarity 0.8 meet in no band with a
probability of 7 in 100,000, more similar ones less.

A bucket of over ``BUCKET`` nodes is first resolved by a star around one of its
nodes. Where that leaves several components, the shingle sets of the bucket are dealt into blocks
of about ``BLOCK`` nodes, and every two blocks are compared by one matrix product, from which only a
spanning star of each linked part leaves: pairs are never rows. Buckets of the same nodes are compared once.

Edge cases: texts without words are alike. Texts of fewer words than a shingle are
one shingle. A null id is no reason to go. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEED, bytes_of, components, materialize, sliced, stars

SIZE, BANDS, ROWS, BUCKET, BLOCK = 5, 24, 5, 4, 512
_RNG = np.random.default_rng(SEED)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    words = bytes_of(text).lower().split()
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.array([h(b" ".join(s), SEED) for s in zip(*[words[i:] for i in range(size)])], np.uint64))


def bands(x: np.ndarray) -> np.ndarray:
    """One value of each band."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 1024):
        y = x[i : i + 1024, None] * FACTORS
        least = np.minimum(least, (y ^ (y >> np.uint64(32))).min(0))
    v = (least.reshape(BANDS, ROWS) * MIX).sum(1, dtype=np.uint64)
    return v ^ (v >> np.uint64(29))


def _nodes(docs: DataFrame, size: int) -> DataFrame:
    """(h, s, n, v) of every text: its hash, that of its shingle set, the set's size and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            s = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            v = pa.array([bands(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array([len(x) for x in sets], pa.int64()), v], ["h", "s", "n", "v"])

    return docs.mapInArrow(run, "h long, s long, n long, v array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "x"])

    return docs.mapInArrow(run, "id long, x array<long>")


def compare(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Spanning stars (a, b) of the links between the nodes of two blocks that are in different components."""
    here, there = pdf[pdf["block"] == pdf["b1"]], pdf[pdf["block"] == pdf["b2"]]
    if not len(here) or not len(there):
        return pd.DataFrame({"a": [], "b": []})
    sets = [*here["x"], *there["x"]]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, column = owner[count[column] > 1], column[count[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(here), len(there)), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, 4096):
        i = slice(*np.searchsorted(column, [at, at + 4096]))
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[i], column[i] - at] = 1
        both += has[: len(here)] @ has[len(here) :].T
    n = np.array([len(x) for x in sets], float)
    hit = both >= least * (n[: len(here), None] + n[None, len(here) :] - both) - 1e-9
    i, j = np.nonzero(hit & (here["part"].to_numpy()[:, None] != there["part"].to_numpy()[None, :]))
    a, b = stars(here["s"].to_numpy()[i], there["s"].to_numpy()[j])
    return pd.DataFrame({"a": a, "b": b})


def classes(docs: DataFrame, text: str = "text", size: int = SIZE, least: float = 0.8) -> DataFrame:
    """(h, component) of every distinct text; h is xxhash64 of the text."""
    texts = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    nodes = materialize(_nodes(texts, size).dropDuplicates(["h"]))
    rows = nodes.groupBy("s").agg(F.min("h").alias("h"), F.first("n").alias("n"), F.first("v").alias("v"))
    met = rows.select("s", "n", F.explode("v").alias("v"))
    buckets = met.groupBy(F.col("v").alias("b_v")).agg(F.count("*").alias("c"), F.min(F.struct("s", "n")).alias("mark")).where("c > 1")
    # By merge: Spark takes the exploded bands for as large as one value a text.
    members = materialize(met.join(buckets.hint("merge"), F.col("v") == F.col("b_v")).select("v", "s", "n", "c", "mark"))
    # Sets of too different sizes cannot be similar.
    alike = (F.least("n", "o_n") >= F.lit(least) * F.greatest("n", "o_n") - 1e-9) & (F.col("s") != F.col("o"))
    pair = [F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")]

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, x): the shingle sets of nodes (id)."""
        hashes = rows.select("s", "h").join(ids, F.col("s") == F.col("id"), "left_semi").select("s", F.col("h").alias("r_h"))
        return materialize(_sets(texts.join(hashes, F.col("h") == F.col("r_h")).dropDuplicates(["s"]).select("s", "text"), size))

    def verified(candidates: DataFrame) -> DataFrame:
        candidates = materialize(candidates.distinct())
        sets = sets_of(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        x, y = sets.select(F.col("id").alias("a"), F.col("x")), sets.select(F.col("id").alias("b"), F.col("x").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return materialize(candidates.join(x, "a").join(y, "b").where(both >= F.lit(least) * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b"))

    small, large = members.where(F.col("c") <= BUCKET).drop("mark"), members.where(F.col("c") > BUCKET)
    other = small.select(F.col("v").alias("o_v"), F.col("s").alias("o"), F.col("n").alias("o_n"))
    few = small.join(other, (F.col("v") == F.col("o_v")) & (F.col("s") < F.col("o")) & alike).select(*pair)
    centred = large.select("s", "n", F.col("mark.s").alias("o"), F.col("mark.n").alias("o_n")).where(alike).select(*pair)
    links = verified(few.union(centred))
    parts = materialize(components(links, "a", "b"))
    # What is in one component needs no more links; a bucket of several components is compared whole, once for all buckets of its nodes.
    named = materialize(large.select("v", "s", "c").join(parts, F.col("s") == F.col("node"), "left").select("v", "s", "c", F.coalesce("component", "s").alias("part")))
    nodes_of = F.bit_xor(F.xxhash64("s"))
    open_ = named.groupBy(F.col("v").alias("b_v")).agg((F.min("part") < F.max("part")).alias("open"), F.max("c").alias("b_c"), nodes_of.alias("of")).where("open")
    open_ = materialize(open_.groupBy("b_c", "of").agg(F.min("b_v").alias("b_v")).select("b_v"))
    if not open_.isEmpty():
        left = named.join(open_, F.col("v") == F.col("b_v"), "left_semi")
        sets = sets_of(left.select(F.col("s").alias("id")).distinct())
        blocks = F.ceil(F.col("c") / BLOCK).cast("int")
        dealt = left.join(sets, F.col("s") == F.col("id")).select("v", "s", "part", "x", F.pmod(F.xxhash64("s"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
        dealt = dealt.select("v", "s", "part", "x", "block", F.least("block", "with").alias("b1"), F.greatest("block", "with").alias("b2"))
        more = dealt.groupBy("v", "b1", "b2").applyInPandas(lambda pdf: compare(pdf, least), "a long, b long")
        parts = components(links.union(materialize(more)), "a", "b")
    return nodes.select("h", "s").join(parts, F.col("s") == F.col("node"), "left").select("h", F.coalesce("component", "s").alias("component"))
