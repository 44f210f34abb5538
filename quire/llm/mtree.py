"""Exact top-k search by M-trees (op3).

Rows are dealt into cells by their nearest of up to ``CELLS`` pivots, k-means of a bounded
sample, and a cell into shards of about ``SHARD`` rows by hash. Each shard is bulk
loaded into an M-tree whose nodes are pages: a leaf holds up to ``PAGE`` vectors
with their distances to the node's pivot, an inner node holds routing pivots with
covering radii and their distances to its own pivot. Trees are stored as a table of
pages; a search decodes the pages that it opens. A query first visits one shard of its
nearest cell. Its k-th score there, and the radii of the cells, tell which cells can hold a better one; only their
shards are visited next. A shard is searched best first: the node with
the best bound is opened next, entries are first bounded by the stored parent
distance and the triangle inequality, and only those that survive get a distance.
The results of a query, k rows a shard at most, are merged by rank.

The largest inner product is the nearest neighbour once vectors are completed to
one length, x' = (x, sqrt(M^2 - |x|^2)), and queries get a zero there. Bounds carry
a slack for rounding and prune only what is strictly worse, so ties are kept;
scores themselves are integers.

Scaled components are whole numbers of any size, held as doubles, which is exact. Products are summed in doubles, 64-bit integers or Python's
integers, the first that is exact for the sizes at hand.

Edge cases: vectors that are null, empty, or hold null or non-finite components take
no part. A score that leaves 64 bits is given as the nearest long, and such scores are ties. Shorter vectors count as if zeros followed. Ties go to the smaller id. All rows with the query's own id are left out; a
query row that repeats is asked once. Rows with a null id take no part. With
fewer than k candidates all are returned. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

PAGE, FAN, SHARD, QUERIES, CELLS, SAMPLE = 256, 16, 8_192, 16_384, 1024, 20_000
SLACK = 1e-9


class Node:
    """A page: pivot, and for each entry its vector, parent distance, radius (inner) and child page or id."""

    __slots__ = ("child", "leaf", "points", "radius", "to_parent")

    def __init__(self, leaf, points, to_parent, radius, child):
        self.leaf, self.points, self.to_parent, self.radius, self.child = leaf, points, to_parent, radius, child


def _distances(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - pivot) ** 2).sum(1))


def build(points: np.ndarray, ids: np.ndarray) -> list[Node]:
    """Pages of the tree over completed points; page 0 is the root."""
    pages: list[Node | None] = []

    def load(rows: np.ndarray, pivot: np.ndarray) -> int:
        """Store the subtree of rows, whose entries measure their parent distance to pivot; its page number."""
        number = len(pages)
        pages.append(None)
        if len(rows) <= PAGE:
            pages[number] = Node(True, points[rows], _distances(points[rows], pivot), None, ids[rows])
            return number
        pivots = spread(points[rows], min(FAN, -(-len(rows) // PAGE) + 1))
        own = nearest(points[rows], pivots)
        if np.bincount(own).max() == len(rows):  # equal points: any split will do
            own = np.arange(len(rows)) % len(pivots)
        parts = [(pivots[i], rows[own == i]) for i in range(len(pivots)) if (own == i).any()]
        routes = np.array([c for c, _ in parts])
        radius = np.array([_distances(points[r], c).max() for c, r in parts])
        child = np.array([load(r, c) for c, r in parts])
        pages[number] = Node(False, routes, _distances(routes, pivot), radius, child)
        return number

    if len(points):
        load(np.arange(len(points)), points.mean(0))
    return pages


def nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.argmin((pivots**2).sum(1)[None, :] - 2 * points @ pivots.T, axis=1)


def spread(points: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n pivots of the points: farthest first over a part of them, then k-means rounds, which shrink the radii."""
    x = points[:: max(1, len(points) // max(1024, 16 * n))]
    pivots = [x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]]
    far = ((x - pivots[0]) ** 2).sum(1)
    for _ in range(n - 1):
        pivots.append(x[np.argmax(far)])
        far = np.minimum(far, ((x - pivots[-1]) ** 2).sum(1))
    c = np.array(pivots)
    for _ in range(rounds):
        own = nearest(x, c)
        total, count = np.zeros_like(c), np.bincount(own, minlength=n)[:, None]
        np.add.at(total, own, x)
        c = np.where(count > 0, total / np.maximum(count, 1), c)
    return c


class Tree:
    """The stored tree of a shard."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        norm = (vectors.astype(float) ** 2).sum(1)
        self.longest = float(norm.max()) if len(norm) else 0.0
        self.points = np.hstack([vectors.astype(float), np.sqrt(np.maximum(0, self.longest - norm))[:, None]])
        self.root = self.points.mean(0) if len(norm) else None
        self.pages = build(self.points, ids)
        self.points = None

    def page(self, number: int) -> Node:
        if isinstance(self.pages[number], bytes):
            self.pages[number] = Node(*pickle.loads(self.pages[number]))
        return self.pages[number]

    def search(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) but own that reach floor, and how many distances were computed."""
        if not self.pages:
            return [], 0
        size = float(query.astype(float) @ query.astype(float))
        q = np.append(query.astype(float), 0.0)
        base, slack = size + self.longest, SLACK * (size + self.longest) + 0.25
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst kept is first
        worst = floor
        heap = [(-np.inf, 0, float(_distances(self.root[None, :], q)[0]))]
        computed = 1
        while heap:
            bound, number, above = heapq.heappop(heap)
            if -bound + slack < worst:
                break
            node = self.page(number)
            near = np.abs(above - node.to_parent)
            if not node.leaf:
                near = np.maximum(0, near - node.radius)
            keep = np.flatnonzero((base - near**2) / 2 + slack >= worst) if worst > -np.inf else np.arange(len(near))
            if not len(keep):
                continue
            computed += len(keep)
            if node.leaf:
                scores, found = _products(node.points[keep, :-1], query), node.child[keep]
                take = (scores >= worst) & (found != own)
                for s, i in zip(scores[take].tolist(), found[take].tolist()):
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                worst = max(floor, best[0][0]) if len(best) == k else floor
            else:
                d = _distances(node.points[keep], q)
                ub = (base - np.maximum(0, d - node.radius[keep]) ** 2) / 2
                for i, u, x in zip(keep, ub, d):
                    if u + slack >= worst:
                        heapq.heappush(heap, (-u, int(node.child[i]), float(x)))
        return [(s, -i) for s, i in sorted(best, reverse=True)], computed


def _products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as the nearest longs."""
    most = np.abs(points).max(initial=0) * max(1.0, np.abs(query).max(initial=0)) * points.shape[1]
    if most < 2**53:
        return (points @ query).astype(np.int64)
    if most < 2**62:
        return points.astype(np.int64) @ query.astype(np.int64)
    q = [int(x) for x in query]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * y for x, y in zip(p, q)))) for p in points.tolist()], np.int64)


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def scaled(vectors: DataFrame, vec: str, key: str, scale: int = 1024) -> DataFrame:
    """(id, v array<double>) of the rows that take part, in whole numbers."""
    x = F.transform(vec, lambda c: c.cast("double") * scale)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c)  # noqa: E731  larger doubles are whole
    return vectors.where(F.col(key).isNotNull() & F.coalesce(F.size(vec) > 0, F.lit(False)) & F.coalesce(fine, F.lit(False))).select(F.col(key).alias("id"), F.transform(x, whole).alias("v"))


def index(rows: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """(cell, part, page, node) of one M-tree per shard of rows (id, v, cell, part); page -1 holds what the whole tree needs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        tree = Tree(_matrix(pdf["v"].tolist(), max(map(len, pdf["v"]))), pdf["id"].to_numpy(np.int64))
        blobs = [pickle.dumps((n.leaf, n.points, n.to_parent, n.radius, n.child)) for n in tree.pages]
        head = pickle.dumps((tree.longest, tree.root))
        return pd.DataFrame({"cell": int(pdf["cell"].iloc[0]), "part": int(pdf["part"].iloc[0]), "page": range(-1, len(blobs)), "node": [head, *blobs]})

    return rows.groupBy("cell", "part").applyInPandas(run, "cell int, part int, page int, node binary")


def _restore(pdf: pd.DataFrame) -> Tree:
    tree = Tree.__new__(Tree)
    head, *tree.pages = pdf.sort_values("page")["node"].tolist()
    tree.longest, tree.root = pickle.loads(head)
    return tree


def _padded(vectors: list, width: int) -> np.ndarray:
    return _matrix([v[:width] for v in vectors], width).astype(float)


def pivots_of(rows: DataFrame, counted: int, shard_rows: int) -> np.ndarray:
    """Pivots of the cells from at most SAMPLE rows."""
    sample = rows.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").toArrow()["v"].to_pylist()
    width = max(map(len, sample), default=1)
    n = max(1, min(CELLS, -(-counted // shard_rows), len(sample)))
    return spread(_padded(sample, width), n) if sample else np.zeros((1, 1))


def in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows (id, v) with cell, the number of the nearest pivot; far, the distance to it; and norm, the squared length."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            width = max(c.shape[1], max(map(len, vectors), default=0))
            x, wide = _padded(vectors, width), np.pad(c, ((0, 0), (0, width - c.shape[1])))
            own = nearest(x, wide) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(((x - wide[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(far), pa.array((x**2).sum(1))], ["id", "v", "cell", "far", "norm"])

    return rows.mapInArrow(run, "id long, v array<double>, cell int, far double, norm double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, vec: str = "embedding", key: str = "vec_id", shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, key, score): for each row of queries its k largest inner products in vectors."""
    rows = scaled(vectors, vec, key)
    counted = rows.count()
    pivots = pivots_of(rows, counted, shard_rows)
    placed = materialize(in_cells(rows, pivots))
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("cell").toPandas()  # one row a cell
    if not len(stats):
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {key} long, score long")
    parts = -(-stats["n"].to_numpy() // shard_rows)
    size = F.create_map(*[F.lit(int(x)) for pair in zip(stats["cell"], parts) for x in pair])[F.col("cell")]
    trees = materialize(index(placed.withColumn("part", F.pmod(F.xxhash64("id", "v"), size).cast("int")), shard_rows))
    asked = materialize(in_cells(scaled(queries, vec, key).distinct(), pivots[stats["cell"].to_numpy()]).select("id", "v", F.xxhash64("v").alias("ask"), F.col("cell").alias("at")))
    blocks = max(1, -(-asked.count() // QUERIES))
    found = vectors.sparkSession.sparkContext.broadcast((pivots[stats["cell"].to_numpy()], stats["radius"].to_numpy(), stats["cell"].to_numpy(), parts))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard of the nearest cell."""
        _, _, cells, sizes = found.value
        for batch in batches:
            at, ask = batch.column(3).to_numpy(), batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cells[at].astype(np.int32)), pa.array((ask % sizes[at]).astype(np.int32)), pa.array(np.full(len(at), -np.inf))], ["id", "v", "ask", "cell", "part", "floor"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All other shards of the cells that can hold a score of at least the floor: q.x = q.c + q.(x - c) <= q.c + |q| radius."""
        c, radius, cells, sizes = found.value
        for batch in batches:
            vectors, ask, at, floor = batch.column(1).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            q = _padded(vectors, c.shape[1])
            rest = np.array([sum(float(x) ** 2 for x in v) for v in vectors])
            long = np.sqrt(rest)[:, None]
            # Rounding grows with the lengths, not with the bound that is left of them.
            keep = q @ c.T + long * radius[None, :] + SLACK * long * (np.sqrt((c**2).sum(1)) + radius)[None, :] + 0.5 >= floor[:, None]
            i, j = np.nonzero(keep)
            i, j = np.repeat(i, sizes[j]), np.repeat(j, sizes[j])
            part = np.concatenate([np.arange(n) for n in sizes[np.nonzero(keep)[1]]]) if len(i) else np.zeros(0, np.int64)
            new = ~((at[i] == j) & (ask[i] % sizes[j] == part))
            i, j, part = i[new], j[new], part[new]
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(pa.array(i)) for n in range(3)], pa.array(cells[j].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(floor[i])], ["id", "v", "ask", "cell", "part", "floor"])

    def search(asks: DataFrame) -> DataFrame:
        def run(ask: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(pages) and len(ask):
                tree = _restore(pages)
                width = len(tree.root) - 1
                for own, v, name, floor in zip(ask["id"].tolist(), ask["v"].tolist(), ask["ask"].tolist(), ask["floor"].tolist()):
                    query = np.zeros(width)
                    query[: min(width, len(v))] = v[:width]
                    hits, computed = tree.search(query, own, k, floor)
                    out += [(own, name, i, s, 0) for s, i in hits]
                    out.append((own, name, None, None, computed))
            columns = list(zip(*out)) or [()] * 5  # each as integers from the start: a null among them would make doubles of them
            return pd.DataFrame({n: pd.array(x, "Int64") for n, x in zip(("query_id", "ask", "found", "score", "computed"), columns)})

        on = ["cell", "part", "block"]
        dealt = asks.withColumn("block", F.pmod(F.col("ask"), F.lit(blocks)).cast("int"))
        copies = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return materialize(dealt.groupBy(*on).cogroup(copies.groupBy(*on)).applyInPandas(run, "query_id long, ask long, found long, score long, computed long"))

    place = "id long, v array<double>, ask long, cell int, part int, floor double"
    near = search(asked.mapInArrow(first, place))
    kth = near.where("found is not null").groupBy("query_id", "ask").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("q"), F.col("ask").alias("a"), "least")
    floored = asked.join(kth, (F.col("id") == F.col("q")) & (F.col("ask") == F.col("a")), "left").select("id", "v", "ask", "at", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("floor"))
    hits = near.union(search(floored.mapInArrow(others, place))).where("found is not null")
    best = W.partitionBy("query_id", "ask").orderBy(F.desc("score"), "found")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias(key), "score")
