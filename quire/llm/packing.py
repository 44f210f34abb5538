"""Best-fit packing of documents into token sequences (op4).

A document's pieces are items with a demand vector (tokens, documents, attention
cost); a sequence is a bin with a capacity for each. An item's vector depends on
its length alone, so best-fit decreasing runs on the histogram of lengths, which
has at most ``tokens`` rows however large the corpus is. Equal bins are one range
of bin numbers: placing c equal items into a range splits it once. Every placement
takes, among the bins that satisfy every constraint, the one with the smallest
weighted residual norm (or the largest weighted dot product).

The plan holds (length, first rank, first bin, offset); each piece finds its row by
its rank among the pieces of its length. Ranks come from a window over
(length, salt) with per-salt offsets, so a length that a third of all pieces share
is ranked by many tasks, and nothing but the histogram and the plan leaves Spark.

Edge cases: a null or empty text is one piece with only the end token. Repeated
rows are packed as often as they occur. Empty tables give no sequences. Lengths
over the capacity are cut: the first piece takes the remainder. Extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_symbols, splitter
from .common import materialize

END = b"\0\0\0\0"
PER_SALT = 250_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds; attention cost of a piece is the square of its length."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], float)


def demand(length: int) -> np.ndarray:
    return np.array([length, 1, length**2], float)


def plan(histogram: dict[int, int], capacity: Capacity, weights: tuple[float, float, float] = (1.0, 0.02, 0.05), select: str = "norm") -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths: (length, first rank, first bin, offset) of every placement.

    select: "norm" takes the bin whose residual after placing has the smallest
    weighted norm, "dot" the one with the largest weighted dot product of demand
    and residual. Ties go to the lowest bin.
    """
    full, w = capacity.vector(), np.array(weights)
    first = np.zeros(0, np.int64)
    count = np.zeros(0, np.int64)
    left = np.zeros((0, 3))
    bins, out = 0, []
    for length in sorted(histogram, reverse=True):
        need, rest, rank = demand(length), histogram[length], 0
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while rest:
            fits = np.flatnonzero((left >= need).all(1))
            if not len(fits):
                per = int(min(full // need)) if length * 2 <= capacity.tokens else 1
                new = -(-rest // per)
                at, room, take = len(first), new, min(rest, new)
                first, count, left = np.append(first, bins), np.append(count, new), np.vstack([left, full])
                bins += new
            else:
                share = (left[fits] - need) / full if select == "norm" else left[fits] / full * (need / full)
                score = np.sqrt((w * share**2).sum(1)) if select == "norm" else -(w * share).sum(1)
                at = int(fits[np.lexsort((first[fits], score))[0]])
                room = int(count[at])
                take = min(rest, room)
            out.append((length, rank, int(first[at]), int(capacity.tokens - left[at, 0])))
            if take < room:
                first, count, left = np.append(first, first[at] + take), np.append(count, room - take), np.vstack([left, left[at]])
                count[at] = take
            left[at] = left[at] - need
            rank, rest = rank + take, rest - take
        keep = left[:, 0] > 0
        first, count, left = first[keep], count[keep], left[keep]
    return out


class Encoded(dict):
    """word -> its ids as little-endian bytes, encoded by the tokenizers library's model; bounded."""

    def __init__(self, model):
        super().__init__()
        self.model, self.symbols = model, byte_symbols()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 250_000:
            self.clear()
        shown = word.replace(" ", self.symbols[32]) if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode("utf-8", "replace")))
        value = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        if len(word) <= 160:
            self[word] = value
        return value


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A function from a text to the bytes of its ids; words that the pre-tokenizer splits off are encoded once."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    words, cache = splitter(), Encoded(t.model)

    def ids(text: str) -> bytes:
        if any(s in text for s in special):
            return np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(cache.__getitem__, words(text)))

    return ids


def pieces(docs: DataFrame, path: str, tokens: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(path)
        for batch in batches:
            rows: list[tuple] = []
            for k, value in enumerate(batch.column(1)):
                ids = ids_of(value.as_py() or "") + END
                n = len(ids) // 4
                cut = [0, *range(n % tokens or min(n, tokens), n, tokens), n]
                rows += [(k, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cut, cut[1:]))]
            columns = list(zip(*rows)) or [()] * 5
            keys = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]], ["key", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", key)


def assign(items: DataFrame, capacity: Capacity, key: str = "doc_id", **how) -> DataFrame:
    """Add sequence_id and offset to a table of pieces; items must be a stored table, as it is read three times."""
    spark = items.sparkSession
    total = items.count()
    salts = max(16, -(-total // PER_SALT))
    salted = items.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)))
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity.tokens rows
    steps = np.array(sorted(plan(histogram, capacity, **how)), np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(steps)  # its size depends on the lengths, not on the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        index = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            row = table[np.searchsorted(index, (length << 44) + rank, side="right") - 1]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], [*[batch.schema.names[i] for i in keep], "sequence_id", "offset"])

    order = W.partitionBy("length", "salt").orderBy(F.col(key).asc_nulls_first(), "piece", "ids_crc32")
    ranked = salted.withColumn("row", F.row_number().over(order) - 1).join(offsets, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
    ranked = ranked.select(*items.columns, (F.col("row") + F.col("base")).cast("long").alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack(docs: DataFrame, path: str, capacity: Capacity = Capacity(), text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """op4: tokenise, cut and pack. The pieces, a few numbers each, are stored once in the shared folder."""
    return assign(materialize(pieces(docs, path, capacity.tokens, text, key)), capacity, key, **how)
