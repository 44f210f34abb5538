"""Embedding near-dedup: spherical k-means cells and blocked cosine products (op9).

Centroids are fitted on a bounded sample (``FIT_ROWS`` distinct vectors a cell, chosen by
hash), for 1, 4, 16 cells and so on; a label takes the number that its own size asks
for. Every distinct vector has its nearest centroid's cell as home and visits
other cells. A vector within angle t of y can have cell c as home only if y lies
within t of the half-space that c wins against y's home h, that is
y.(h - c) <= sin(t) |h - c|; these cells are open to y. Two linked vectors have each
other's home open, so it is enough that the one with the higher home visits the
lower: y visits all open cells below its home, no link can be lost and every pair is compared in one cell.

A (label, cell) is one matrix product in double precision while it has at most ``BLOCK``
members at home and as many visitors. A larger one, which only many vectors close to each other or more than
BLOCK * ``MAX_CELLS`` of one label make, is dealt into blocks: every two home blocks and every home and visitor
block are one group. Close vectors are links that have to be counted, so
that work is as large as what it finds. Only counts and a spanning star of
each connected part leave a group. Equal vectors are one member with a weight, so copies are never
paired.

Edge cases: a null label, or a vector that is null, empty, zero or holds null or
non-finite components links with nothing and is kept. Vectors of different
lengths are never compared. Rows that repeat a vec_id with the same vector count
as copies. A null vec_id links with nothing. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, keyed_join, materialize, stars

BLOCK, CELL, FIT_ROWS, MAX_CELLS, SLICE = 2048, 1024, 16, 4096, 1024


def usable(vec: str) -> F.Column:
    """A vector with components, all finite, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0) & (F.size(vec) > 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit(distinct: DataFrame, most: int, rounds: int = 8) -> dict[tuple[int, int], np.ndarray]:
    """Centroids by (vector length, number of cells), for 1, 4, 16 cells and so on up to most.

    Spherical k-means over a sample of ``FIT_ROWS`` vectors for each cell; the driver sees at
    most FIT_ROWS * MAX_CELLS of them.
    """
    sample = distinct.select("vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(max(2000, FIT_ROWS * most)).select(F.transform("vec", lambda x: x.cast("double")).alias("vec")).toArrow()["vec"]
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v.values), []).append(v.values.to_numpy())
    out = {}
    for size, rows in by.items():
        x, cells = unit(np.array(rows)), 1
        while cells <= most:
            c = x[:: max(1, len(x) // cells)][:cells]
            for _ in range(rounds):
                # In slices: the products of a whole sample with all centroids would fill the driver.
                near = np.concatenate([(x[i : i + SLICE] @ c.T).argmax(1) for i in range(0, len(x), SLICE)])
                total = np.zeros_like(c)
                np.add.at(total, near, x)
                n = np.linalg.norm(total, axis=1, keepdims=True)
                c = np.where(n > 1e-9, total / np.maximum(n, 1e-9), c)
            out[size, cells] = c
            cells *= 4
    return out


class Cells:
    """Centroids by (vector length, number of cells), and their distances, found once in each process that asks."""

    def __init__(self, centroids: dict[tuple[int, int], np.ndarray]):
        self.centroids, self.distances = centroids, {}

    def get(self, size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """A length that the sample has missed has one centroid."""
        c = self.centroids.get((size, cells))
        if c is None:
            c = np.ones((1, size)) / np.sqrt(size)
        if (size, len(c)) not in self.distances:
            self.distances[size, len(c)] = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
        return c, self.distances[size, len(c)]


def homes_and_visits(x: np.ndarray, c: np.ndarray, apart: np.ndarray, cosine: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The home cell of each unit vector, and the cells that it is compared in: its home, then the open ones below. apart: the centroids' distances."""
    homes, out = [], []
    for i in range(0, len(x), 512):
        score = x[i : i + 512] @ c.T
        home = score.argmax(1)
        best = score[np.arange(len(home)), home][:, None]
        may = best - score <= np.sqrt(max(0.0, 1 - cosine**2)) * apart[home] + 1e-9
        homes.append(home)
        out += [np.concatenate([[h], np.flatnonzero(row[:h])]) for h, row in zip(home, may)]
    return np.concatenate(homes), out


def compare(a: pd.DataFrame, b: pd.DataFrame, cosine: float, same: bool) -> pd.DataFrame:
    """Counts and star edges of the links between two blocks of one cell."""
    x, y = unit(np.array(a["vec"].tolist(), float)), unit(np.array(b["vec"].tolist(), float))
    hit = x @ y.T >= cosine
    if same:
        np.fill_diagonal(hit, False)
    i, j = np.nonzero(hit)
    rid, rjd, wa, wb = a["rid"].to_numpy(), b["rid"].to_numpy(), a["n"].to_numpy(), b["n"].to_numpy()
    count_a = np.bincount(i, weights=wb[j], minlength=len(a)).astype(np.int64)
    parts = [pd.DataFrame({"rid": rid, "other": pd.array([None] * len(a), "Int64"), "links": count_a})[count_a > 0]]
    if not same:
        count_b = np.bincount(j, weights=wa[i], minlength=len(b)).astype(np.int64)
        parts.append(pd.DataFrame({"rid": rjd, "other": pd.array([None] * len(b), "Int64"), "links": count_b})[count_b > 0])
    if len(i):
        u, v = stars(rid[i], rjd[j])
        parts.append(pd.DataFrame({"rid": u, "other": pd.array(v, "Int64"), "links": 0}))
    return pd.concat(parts)


def link(vectors: DataFrame, cosine: float = 0.98, vec: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(rid, label, vec, n, links, component): distinct vectors, how many rows each stands for, their links and component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("rid"), F.col(label).alias("label"), F.col(vec).alias("vec")).where(usable("vec") & F.col("label").isNotNull() & F.col("rid").isNotNull())
    distinct = materialize(rows.groupBy("label", "vec").agg(F.min("rid").alias("rid"), F.count("*").alias("n")))
    # A label's own size gives its number of cells, 1, 4, 16 and so on, of CELL vectors or fewer while that is possible.
    power = F.greatest(F.lit(0.0), F.ceil(F.log(4.0, F.col("size") / CELL)))
    sizes = materialize(distinct.groupBy(F.col("label").alias("of")).agg(F.count("*").alias("size")).withColumn("cells", F.least(F.lit(MAX_CELLS), F.pow(F.lit(4.0), power)).cast("int")))
    most = sizes.agg(F.max("cells")).first()[0] or 1
    centroids = spark.sparkContext.broadcast(Cells(fit(distinct, most)))  # at most 4/3 MAX_CELLS a vector length
    sized = keyed_join(distinct, sizes, F.col("label") == F.col("of"), "size")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            lengths, cells = np.array([len(v) for v in vecs]), batch.column(4).to_numpy()
            out = []
            for d, k in {*zip(lengths.tolist(), cells.tolist())}:
                at = np.flatnonzero((lengths == d) & (cells == k))
                home, visits = homes_and_visits(unit(np.array([vecs[i] for i in at], float)), *centroids.value.get(d, k), cosine)
                out += [(i, d, int(h), v.tolist()) for i, h, v in zip(at, home, visits)]
            out.sort()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), batch.column(3), pa.array([int(o[1]) for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.list_(pa.int32()))], ["label", "rid", "vec", "n", "dim", "home", "visits"])

    kind = distinct.schema["label"].dataType.simpleString()
    vtype = distinct.schema["vec"].dataType.simpleString()
    rtype = distinct.schema["rid"].dataType.simpleString()
    placed = sized.select("label", "vec", "rid", "n", "cells").mapInArrow(place, f"label {kind}, rid {rtype}, vec {vtype}, n long, dim int, home int, visits array<int>")
    members = placed.withColumn("cell", F.explode("visits")).withColumn("guest", F.col("home") != F.col("cell")).drop("visits", "home")
    group = ["label", "dim", "cell"]
    blocks = [F.ceil(F.count_if(c) / BLOCK).cast("int").alias(n) for c, n in ((~F.col("guest"), "own"), (F.col("guest"), "guests"))]
    sizes = members.groupBy(*group).agg(*blocks).select(*[F.col(g).alias("g_" + g) for g in group], "own", "guests").where("own > 0")
    on = [F.col(g) == F.col("g_" + g) for g in group]
    # Home blocks are numbered first, then those of the guests, which meet home blocks only.
    block = F.when(F.col("guest"), F.col("own") + F.pmod(F.xxhash64("rid", "label"), F.col("guests"))).otherwise(F.pmod(F.xxhash64("rid", "label"), F.col("own")))
    dealt = members.join(sizes, on).withColumn("block", block.cast("int"))
    others = F.sequence(F.lit(0), F.col("own") - 1 + F.when(F.col("guest"), 0).otherwise(F.col("guests")))
    pairs = dealt.withColumn("with", F.explode(others)).select("label", "dim", "cell", "rid", "vec", "n", "block", F.least("block", "with").alias("b1"), F.greatest("block", "with").alias("b2"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b1, b2 = int(pdf["b1"].iloc[0]), int(pdf["b2"].iloc[0])
        a = pdf[pdf["block"] == b1]
        b = pdf[pdf["block"] == b2]
        if not len(a) or not len(b):
            return pd.DataFrame({"rid": [], "other": [], "links": []})
        return compare(a, b, cosine, b1 == b2)

    found = materialize(pairs.groupBy(*group, "b1", "b2").applyInPandas(run, f"rid {rtype}, other {rtype}, links long"))
    counts = found.where("other is null").groupBy("rid").agg(F.sum("links").alias("links")).withColumnRenamed("rid", "c_rid")
    parts = components(found.where("other is not null"), "rid", "other")
    out = distinct.join(counts, F.col("rid") == F.col("c_rid"), "left").join(parts, F.col("rid") == F.col("node"), "left")
    return out.select("rid", "label", "vec", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rid").alias("component"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, vec: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """op9: (key, n_links, component_id, kept) of every row."""
    classes = link(vectors, cosine, vec, key, label).select(F.col("label").alias("c_label"), F.col("vec").alias("c_vec"), "links", "component")
    rows = vectors.select(F.col(key), F.col(label).alias("r_label"), F.col(vec).alias("r_vec"))
    out = rows.join(classes, (F.col("r_label") == F.col("c_label")) & (F.col("r_vec") == F.col("c_vec")) & F.col(key).isNotNull(), "left")
    component = F.coalesce("component", key)
    return out.select(key, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(True)).alias("kept"))
