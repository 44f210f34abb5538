"""Ordered work on one document at a time, without a group's detour through pandas."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def per_document(df: DataFrame, run: Callable[[list], list[tuple]], schema: str, key: str = "doc_id", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Rows of schema from run(rows of one key in order); a task holds one key's rows at a time.

    One shuffle by key and one sort; documents are as large as a document, so no group is unbounded.
    """
    spark = df.sparkSession
    out = to_arrow_schema(spark.createDataFrame([], schema).schema)
    names, at = df.columns, df.columns.index(key)
    size = 4096

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(out)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], names=out.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = namedtuple("row", names)
        held, done = [], []
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns)):
                if held and values[at] != held[0][at]:
                    done += run(held)
                    held = []
                    if len(done) >= size:
                        yield batch(done)
                        done = []
                held.append(row(*values))
        if held:
            done += run(held)
        if done:
            yield batch(done)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(work, schema)
